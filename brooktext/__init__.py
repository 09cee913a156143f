"""A PySpark-native engine that scores generated text under vocabulary constraints.

functions: column expressions. sources: readers, writers and their checks. operators: DataFrame in, DataFrame out.
plans: the registered queries and the whole scoring plan. streaming: the same scoring over a stream of files.
"""
