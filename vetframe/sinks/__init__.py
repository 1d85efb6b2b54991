"""Writers of datasets and reports."""
