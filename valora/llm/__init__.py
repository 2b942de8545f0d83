"""Operators of a training-data pipeline: decontamination, top-k search,
license scan, language id, quality classifier, WARC, packing, SimHash
near-duplicates, LM scoring, secret scan.  Nothing outside this subpackage (and
``corpus_pipeline.py``) imports it."""
