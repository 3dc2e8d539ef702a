"""gridloom: profile, prepare, model and score any table with Spark."""
