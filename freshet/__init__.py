"""freshet: river-flow features on Spark.

Every function takes DataFrames or Columns and returns them; nothing here runs
an action except the few places that say so (one-hot domains, model fitting,
sinks).  Layout:

* ``functions``  column expressions (numbers, dates, text, nested data, rings)
* ``operators``  table operators (series, joins, nearest station, polygons, grids)
* ``sources``    readers for landed files, and the writers
* ``plans``      the end-to-end jobs built from the operators
"""
