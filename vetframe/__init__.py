"""Dataset-quality analytics as lazy DataFrame operators."""
