"""foliomill: literature mining as Spark jobs.

Documents go in, analysis-ready tables come out.  Every operator is a function
from DataFrame to DataFrame (or Column to Column) that stays lazy; callers decide
when to write.
"""

__version__ = "0.1.0"
