from postweave.streaming.scores import score_stream, stream_confusion

__all__ = ["score_stream", "stream_confusion"]
