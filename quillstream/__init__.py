"""quillstream: a DataFrame-first analytics library for monitored-page publication feeds."""
