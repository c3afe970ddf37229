"""Reading and writing: Parquet tables, sharded documents, serving tables, snapshots, caches."""
