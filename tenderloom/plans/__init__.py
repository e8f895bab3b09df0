"""Reports, serving queries and the ingestion job."""
