"""Complete jobs: build, search, evaluate, re-index."""
