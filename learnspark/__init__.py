"""learnspark: learning analytics and document curation as Spark jobs."""
