"""quern: a batch SQL and data-processing engine on PySpark.

Scripts of ``;``-separated statements are parsed by a small front end and
lowered to Spark SQL / DataFrame plans; ``operators`` holds the data-processing
operators that Spark does not ship, ``llm`` the optional text operators.
"""

__version__ = "0.1.0"
