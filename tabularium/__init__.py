"""Questions over large collections of small tables, answered by Spark: search, selection, calculation, evaluation."""
