"""Training-data operators (``opN_*`` queries). Nothing else in the library imports this package."""
