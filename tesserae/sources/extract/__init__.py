"""From the bytes of a file to its units: pure functions of the bytes, run once for each blob."""
