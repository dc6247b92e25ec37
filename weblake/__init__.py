"""Web-server log analytics as Spark jobs: sources, parsing, search, facets, dashboards, maps and incremental tables."""
