"""Spark-first engine for curating, linking, screening and evaluating record collections.

``functions``  pure Column expressions (text, dates, verdicts, scores)
``operators``  DataFrame -> DataFrame building blocks (dedupe, link, window filters, evaluation, routing)
``sources``    readers and writers (BibTeX, keyed JSONL, CSV, text lists)
``plans``      the registered queries with their oracle SQL
``streaming``  Structured Streaming counterparts (resume, dead letters, event windows)
"""
