"""DataFrame-to-DataFrame operators; fits return small parameter objects."""
