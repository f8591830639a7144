"""quillon: evidence-centred analytics and corpus preparation expressed as Spark DataFrame plans."""
