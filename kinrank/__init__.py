"""kinrank: related-item ranking as Spark DataFrame jobs.

Layers:
  sources/    loaders for items, change groups, change logs, exclusions
  functions/  Catalyst column expressions (tokens, names, string similarity)
  operators/  relational building blocks (co-change, statistics, set joins,
              reference edges, top-k)
  plans/      end-to-end jobs (item features, relatedness scoring)

"""

__version__ = "0.1.0"
