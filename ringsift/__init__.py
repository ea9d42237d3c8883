"""ringsift: phone-number reputation and call-event analytics as Spark jobs."""

__version__ = "0.1.0"
