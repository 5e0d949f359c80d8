import sys

from quern.job import main

sys.exit(main(sys.argv[1:]))
