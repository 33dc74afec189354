"""Training-data operators: filtering, de-duplication, scanning, mixing,
tokenising, packing and exact search. Nothing else in the library imports
this subpackage."""
