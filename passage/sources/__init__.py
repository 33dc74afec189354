"""Sources: raw scan logs (batch / stream), processed datasets, models, and
the adapter that turns the ``events`` test table into detections."""
