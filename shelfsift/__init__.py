"""Catalogue analytics on Spark: merge, classify, de-duplicate, rank, plan and report over a table of files.

``functions``  column expressions (text, paths, displays, fingerprints)
``operators``  DataFrame -> DataFrame jobs
``plans``      target-path planning and composed flows
``sources``    readers and writers
``streaming``  Structured Streaming jobs for newly arriving files
"""
