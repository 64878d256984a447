"""Layer-building plans composed from operators."""
