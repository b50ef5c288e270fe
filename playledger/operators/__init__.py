"""DataFrame-to-DataFrame operators; none of them collects or caches."""
