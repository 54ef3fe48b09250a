"""ledgerscope — ledger forensics as Spark DataFrame operators.

Every public operator takes and returns DataFrames; thresholds are keyword parameters whose defaults
are the reference rules.  Operators that read an intermediate several times, fit models or write to a
store run Spark jobs when they are called.
"""

from ledgerscope.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
