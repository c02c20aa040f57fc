"""DataFrame-to-DataFrame operators on series, intervals, labels and forecasts."""
