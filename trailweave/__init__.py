"""Trail and transit analytics as Spark plans."""
