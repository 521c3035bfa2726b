"""DataFrame to DataFrame operators over pages, images, layers, content operators and jobs."""
