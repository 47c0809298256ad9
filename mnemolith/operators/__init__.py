"""Dataframe operators: filters, search, ranking, graph, versions, lifecycle, writes, statistics, evaluation."""
