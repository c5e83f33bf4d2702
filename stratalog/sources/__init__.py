"""Where versioned metadata comes from: schemas, derived tables, delta logs and listings."""
