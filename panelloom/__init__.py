"""Panel-graph analytics on Spark: panels, graphs between series and time points, profiles, imputation, scores."""
