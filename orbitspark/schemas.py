"""Schemas of the tables that files are read into."""

from __future__ import annotations

POINTS = "run_id string, point_id long, x double, y double, z double, r int, g int, b int, error double"
CAMERAS = ", ".join(["run_id string", "frame_id string", "width int", "height int", "model string", "fx double", "fy double", "cx double", "cy double", *(f"r{i}{j} double" for i in range(3) for j in range(3)), "t0 double", "t1 double", "t2 double"])
VIDEO_JSON = """streams array<struct<codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,r_frame_rate:string,duration:string,nb_frames:string,tags:map<string,string>,
side_data_list:array<struct<rotation:double>>>>, format struct<format_name:string,duration:string,size:string>"""
CHECKSUMS = "path string, sha256 string"
