"""Jobs made of several steps: the tier store, migration, change batches, replay."""
