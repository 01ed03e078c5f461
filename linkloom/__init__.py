"""linkloom: turn large collections of saved web links into a labelled dataset, on Spark."""
