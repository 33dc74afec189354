"""passage — footfall analytics as Spark DataFrame operators.

Raw scan logs of anonymised device sightings become per-site crowd time
series: clean → presence filter → per-scan counts → tumbling windows →
lag / rolling features → traffic patterns → forecasts → read models.
Every operator is a DataFrame → DataFrame function keyed by ``site_id``.
"""

from passage.config import Config

__all__ = ["Config"]
__version__ = "0.1.0"
