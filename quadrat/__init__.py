"""quadrat: biodiversity and household-survey analytics as Spark DataFrame jobs."""
