"""DataFrame → DataFrame operators, all keyed by ``site_id`` by default."""

DEFAULT_KEYS = ("site_id",)
