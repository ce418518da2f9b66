"""Training-data operators: ten building blocks of a corpus pipeline.

Nothing outside this subpackage imports it; ``queries.py`` lists its
queries and their SQL twins.
"""
