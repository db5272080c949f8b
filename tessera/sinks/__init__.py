"""Where results leave: drawings and reports. Only here are rows gathered, and only up to a stated number."""
