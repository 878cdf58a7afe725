"""Spark operators over corpora of rich documents: blocks, runs, comments, revisions, styles, pages and edit feeds."""
