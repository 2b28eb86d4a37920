"""Row transforms, folds, denormalisation and distinct-value evaluation over DataFrames."""
