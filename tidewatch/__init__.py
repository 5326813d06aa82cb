"""tidewatch: find and explain traffic spikes in hourly counts, on Spark."""

from tidewatch.params import EventParams, PeakParams, TemplateParams

__all__ = ["EventParams", "PeakParams", "TemplateParams"]
