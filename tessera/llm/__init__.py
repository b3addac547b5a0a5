"""Training-data pipeline operators.

One module per operator; ``registry`` lists the queries and their SQL. Nothing
outside this subpackage imports it.
"""
