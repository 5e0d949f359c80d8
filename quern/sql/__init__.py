"""The query dialect: text to tokens, tokens to syntax, syntax to Spark SQL."""
