"""DataFrame operators over catalog, transcript, slide, progress and benchmark relations."""
