def texts_of(spark, sf_dir):
    """Text by doc_id, null as empty."""
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
