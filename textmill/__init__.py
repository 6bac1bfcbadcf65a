"""textmill: content cleaning, token analytics and corpus operators as Spark jobs.

Every operator is a function from DataFrame to DataFrame.
"""
