"""Spark-first road-traffic analytics: networks, routes, congestion, clustering, planning windows."""
