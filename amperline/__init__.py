"""amperline: interval-market analytics and corpus operators expressed as Spark jobs."""
