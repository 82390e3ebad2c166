"""Customer segmentation: preparation, candidates, metrics, final model, profiles."""
