"""Named pipelines: experiments, named indexes, the query registry and its DuckDB oracles."""
