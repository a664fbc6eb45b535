"""Ridgeline: bulk analytics over ITL biometric transaction files on Spark."""
