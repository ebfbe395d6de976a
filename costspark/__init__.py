"""Cloud cost and usage analytics as plain DataFrame functions.

Every operator takes DataFrames (plus an explicit ``as_of`` date where the
question is relative to "today") and returns one lazy DataFrame.  Nothing here
runs a Spark job unless its name says so (``write_*``, ``materialise_*``,
``save_*``, ``run_*``).
"""
