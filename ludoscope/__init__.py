"""Game-market analytics as Spark plans: catalogues, event windows, marts, graph, reports."""
