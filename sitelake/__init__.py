"""sitelake: web-archive and notes-corpus analytics as PySpark jobs."""
