"""Training-data operators for language-model pipelines. Nothing outside this subpackage imports it."""
