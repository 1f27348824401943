"""loomtext: text analytics as Spark plans."""
