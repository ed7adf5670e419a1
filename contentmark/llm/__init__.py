"""Training-data operators: mixing, classifiers, rules, formatting, token
files, de-duplication, nearest neighbours and packing as Spark jobs.

Nothing outside this subpackage imports it.  Every operator selects the
columns it needs by name first, so extra columns of any name pass through
or are ignored; internal columns start with ``_x_``.
"""
