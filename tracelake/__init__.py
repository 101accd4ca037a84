"""PySpark-native analytics for tool-call trajectories and training corpora."""
