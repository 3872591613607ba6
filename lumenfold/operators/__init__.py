"""DataFrame operators: joins, matching, sampling, curves, quality, evaluation."""
