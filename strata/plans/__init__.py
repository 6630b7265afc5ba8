"""The query catalog: every operator over the driver's tables, with the SQL that says what it must return."""
