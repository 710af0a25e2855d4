"""DataFrame operators: joins in time, summaries, ordered series, ranking, prediction, alignment and calibration."""
