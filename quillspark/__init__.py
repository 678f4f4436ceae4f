"""Document-layout and transcription-review engine on PySpark."""

__version__ = "0.1.0"
