"""Query catalogue over the test tables, each with the SQL it must agree with where SQL can express it."""
