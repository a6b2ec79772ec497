from tessera.streaming.incremental import IncrementalInference, windowed_counts

__all__ = ["IncrementalInference", "windowed_counts"]
