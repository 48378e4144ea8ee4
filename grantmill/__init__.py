"""Patent cleaning, integrity repair and analytics as PySpark DataFrame jobs."""
