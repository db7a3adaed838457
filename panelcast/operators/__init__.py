"""DataFrame operators keyed by series: resampling, gap filling, quality, lags, VAR models."""
