"""almucantar: sky, terrain and climate analytics as Spark DataFrame operators."""
