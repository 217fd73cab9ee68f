"""Plan-level helpers: shared work folders, guarded joins, distributed ranks and prefix sums."""
