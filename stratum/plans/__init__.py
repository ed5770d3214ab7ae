"""Models, pipelines, documents: what is declared before anything runs."""
