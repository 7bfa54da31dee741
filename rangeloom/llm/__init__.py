"""Training-data pipeline operators.

Nothing else in the library imports this subpackage.  Conventions shared by all
operators:

* input frames may carry any further columns; only the named ones are read;
* a null text counts as an empty one unless the operator says otherwise;
* repeated rows are kept apart: one output row per input row;
* text comes out whole, no operator samples, caps or cuts its input.
"""
