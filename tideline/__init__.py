"""Analytics over multichannel time series, spectra, events and verdicts as Spark DataFrames."""
