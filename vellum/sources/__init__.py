"""Sources and sinks: files, inline requests, URLs, page images, stored tables."""
