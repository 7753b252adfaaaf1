"""From syntax trees to DataFrames."""
