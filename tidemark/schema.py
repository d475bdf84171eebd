"""Schemas of the signal model, as DDL."""

#: A clip's metadata, and its samples as chunks of one channel.
CLIPS = "clip_id string, title string, tags array<string>, sample_rate int, channels int, n_frames bigint"
SIGNAL_CHUNKS = "clip_id string, channel int, chunk_idx bigint, start_frame bigint, frame_count int, samples array<float>"
#: A uniform series of a metric; and min/max pyramids.
SERIES = "clip_id string, metric string, block_idx bigint, t_seconds double, value double"
PYRAMID = "clip_id string, channel int, level int, bucket bigint, vmin double, vmax double"
RIFF_CHUNKS = "file string, idx int, id string, offset decimal(20,0), size decimal(20,0), padded decimal(20,0), size_field decimal(20,0)"
BIQUAD = "b0 double, b1 double, b2 double, a1 double, a2 double"
