from ledgerfold.plans import queries, traces  # noqa: F401  both register what they hold
