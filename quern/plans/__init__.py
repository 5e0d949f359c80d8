"""Ready queries over the data tables, used by the driver entry."""
