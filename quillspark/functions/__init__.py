"""Column functions, the output type language, prompt templates and model clients."""
