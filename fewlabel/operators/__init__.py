"""DataFrame operators: sampling, moments, inference, screening."""
