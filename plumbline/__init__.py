"""Building inspection from 3-D point clouds, as DataFrame operators on Spark."""
